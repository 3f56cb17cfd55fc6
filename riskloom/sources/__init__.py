"""riskloom.sources"""
