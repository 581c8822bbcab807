"""Spark-native monitoring analytics: detections to tracks, motion states, events and audits."""
