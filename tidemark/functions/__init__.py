"""Scalar expressions: calendar, arithmetic with the null rules of the bar tables."""
