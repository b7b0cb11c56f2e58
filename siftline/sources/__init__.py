"""siftline.sources"""
