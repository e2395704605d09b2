"""widecairn.streaming"""
