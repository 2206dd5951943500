"""Spark-native sample augmentation and annotation engine.

``operators``  pixel, geometric, dropout, mixing and volumetric operators over the pixel relation
``functions``  column helpers: seeded randomness, boxes, keypoints, colour spaces
``plans``      composition of operators, replay and portable pipeline specifications
``sources``    readers and writers for samples and their relations
``streaming``  the same operators over streams of samples
"""
