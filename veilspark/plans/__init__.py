"""veilspark.plans"""
