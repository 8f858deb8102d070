"""Reads, recall, lineage, folds, timers, distillation, maintenance as DataFrame transformations."""
