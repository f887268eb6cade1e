"""kvloom.operators"""
