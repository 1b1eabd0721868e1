"""scriptspark: Spark-native text-to-script and audio-timeline engine."""
