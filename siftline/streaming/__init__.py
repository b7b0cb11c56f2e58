"""siftline.streaming"""
