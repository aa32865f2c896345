"""askframe.streaming"""
