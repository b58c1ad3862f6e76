"""Catalog modules; importing them registers every key."""

from turfline.plans.queries import (q_dash, q_features, q_index, q_ingest, q_ml, q_scoring, q_serve, q_text,  # noqa: F401
                                     q_stream, q_upsert, q_vectors)
