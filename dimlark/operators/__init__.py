"""dimlark.operators"""
