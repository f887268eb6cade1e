"""kvloom.sources"""
