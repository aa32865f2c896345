"""askframe.plans"""
