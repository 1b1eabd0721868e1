"""scriptspark.functions"""
