"""siftline.functions"""
