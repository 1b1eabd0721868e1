"""scriptspark.operators"""
