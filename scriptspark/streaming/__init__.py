"""scriptspark.streaming"""
