"""kvloom.streaming"""
