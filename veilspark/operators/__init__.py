"""veilspark.operators"""
