"""askframe.sources"""
