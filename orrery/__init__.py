"""Spark-native operators for posed-camera, spatial question-answering and text data."""
