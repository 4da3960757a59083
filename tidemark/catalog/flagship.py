"""One round of every consumer: fetch what is pending, then move the offsets."""

from tidemark.catalog.inputs import K, ORDER, OWNER, ev, offsets
from tidemark.operators.fetch import pending_per_consumer
from tidemark.operators.offsets import advance_offsets
from tidemark.plans.workspace import settle


def flagship(spark, sf_dir):
    events = ev(spark, sf_dir)
    stored = settle(offsets(events), "offsets")
    batches = pending_per_consumer(events.select("index_name", *ORDER), stored, K, ORDER)
    return advance_offsets(settle(batches, "batches"), stored, OWNER, ORDER)
