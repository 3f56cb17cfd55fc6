"""riskloom.operators"""
