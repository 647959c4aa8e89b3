"""Typed tables, marts, metrics, checks and figures. Every operator maps frames to a frame."""
