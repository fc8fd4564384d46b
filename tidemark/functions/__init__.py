"""Scalar functions, predicates and folds: each lowers to Spark columns."""
