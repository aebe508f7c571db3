"""dimlark.plans"""
