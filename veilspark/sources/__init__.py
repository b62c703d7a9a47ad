"""veilspark.sources"""
