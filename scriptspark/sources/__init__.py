"""scriptspark.sources"""
