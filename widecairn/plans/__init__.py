"""widecairn.plans"""
