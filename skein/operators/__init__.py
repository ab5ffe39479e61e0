"""Relational operators, ordered folds, classification and statistics."""
