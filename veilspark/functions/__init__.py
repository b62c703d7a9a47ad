"""veilspark.functions"""
