"""trackloom.streaming"""
