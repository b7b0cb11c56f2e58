"""siftline.operators"""
