"""dimlark.streaming"""
