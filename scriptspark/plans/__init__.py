"""scriptspark.plans"""
