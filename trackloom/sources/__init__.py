"""trackloom.sources"""
