"""Spark-native engine that turns collections of documents into clean, ordered, speakable scripts."""
