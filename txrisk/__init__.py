"""Spark-native transaction-risk scoring by nearest neighbours."""
