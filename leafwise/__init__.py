"""Spark toolkit for catalogues of ordered page sequences."""
