"""trackloom.operators"""
