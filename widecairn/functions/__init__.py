"""widecairn.functions"""
