"""kvloom.functions"""
