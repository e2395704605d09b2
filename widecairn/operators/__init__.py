"""widecairn.operators"""
