"""kvloom.plans"""
