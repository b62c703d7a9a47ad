"""veilspark.streaming"""
