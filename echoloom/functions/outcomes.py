"""Estimates about a finished ticket, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom import constants as K
from echoloom.functions.scores import hours_between
from echoloom.functions.steps import at_most, below, clamp


def resolution_hours(status: Column, created: Column, updated: Column) -> Column:
    return F.when(status.isin(K.DONE_STATUSES), hours_between(created, updated))


def actual_priority(hours: Column, status: Column, kind: Column) -> Column:
    speed = below(hours, [(1, 0.9), (24, 0.7), (168, 0.5)], 0.3)
    state = F.when(status == "closed", 1.0).when(status == "resolved", 0.9).otherwise(0.7)
    weight = F.when(kind == "bug", 1.2).when(kind == "feature_request", 0.8).when(kind == "performance", 1.1).otherwise(1.0)
    return F.when(hours.isNull(), 0.5).otherwise(clamp(speed * state * weight))


def resolution_quality(hours: Column, status: Column, kind: Column) -> Column:
    state = F.when(status == "closed", 0.3).when(status == "resolved", 0.2).otherwise(0.0)
    speed = F.when(hours < 24, 0.2).when(hours > 168, -0.1).otherwise(0.0)
    # a time of exactly zero hours does not count for the bug rule
    bug = F.when((kind == "bug") & (hours != 0) & (hours < 48), 0.1).when((kind == "bug") & (hours > 168), -0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + state + speed + bug)


def satisfaction(hours: Column, status: Column) -> Column:
    state = F.when(status == "closed", 0.1).when(status == "resolved", 0.05).otherwise(0.0)
    return F.when(hours.isNotNull(), clamp(below(hours, [(24, 0.8), (168, 0.6)], 0.4) + state))


def business_impact(hours: Column, kind: Column, component: Column) -> Column:
    by_kind = F.when(kind == "bug", 0.2).when(kind == "performance", 0.1).when(kind == "feature_request", -0.1).otherwise(0.0)
    speed = F.when(hours < 24, -0.1).when(hours > 168, 0.1).otherwise(0.0)
    part = F.when(component.isin("authentication", "payment", "core"), 0.1).when(component.isin("ui", "ux"), -0.05).otherwise(0.0)
    return clamp(F.lit(0.5) + by_kind + speed + part)


def classification_accuracy(kind: Column, body: Column) -> Column:
    size = F.coalesce(F.length(body), F.lit(0))
    return F.when(kind.isNull(), 0.0).when(size > 200, 0.8).when(size > 100, 0.6).otherwise(0.4)


def clustering_accuracy(cluster_size: Column) -> Column:
    return F.when(cluster_size.isNull(), 0.0).when(cluster_size > 5, 0.8).when(cluster_size > 2, 0.6).otherwise(0.4)


def time_accuracy(hours: Column) -> Column:
    return at_most(hours, [(4, 1.0), (24, 0.8), (168, 0.6), (720, 0.4)], 0.2)


def ticket_satisfaction(hours: Column, status: Column) -> Column:
    speed = F.when(hours < 24, 0.3).when(hours < 168, 0.1).when(hours.isNotNull(), -0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + speed + F.when(status == "closed", 0.2).otherwise(0.0))


def ticket_impact(kind: Column, component: Column) -> Column:
    by_kind = F.when(kind == "bug", 0.2).when(kind == "performance", 0.1).when(kind == "feature_request", -0.1).otherwise(0.0)
    part = F.when(component.isin("authentication", "payment", "core"), 0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + by_kind + part)
