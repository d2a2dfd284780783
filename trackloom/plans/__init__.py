"""trackloom.plans"""
