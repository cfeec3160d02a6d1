"""Nothing streams: the engine answers questions over tables. Spark's readers and writers of streams are free to use around it."""
