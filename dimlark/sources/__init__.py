"""dimlark.sources"""
