"""widecairn.sources"""
