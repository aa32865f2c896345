"""askframe.operators"""
