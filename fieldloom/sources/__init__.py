"""fieldloom.sources"""
