"""Ranked-event analytics as PySpark DataFrame functions.

Entrants belong to teams, meet in a sequence of events and finish in an order.
Events are grouped in *series* (independent championships); every window and
join key starts with the series, so one hash partitioning by series serves the
whole feature pipeline.
"""
