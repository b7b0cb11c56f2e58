"""siftline.plans"""
