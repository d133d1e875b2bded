"""Part of larkspan."""
