"""Spark jobs that rebuild large flat images from many overlapping scans."""
