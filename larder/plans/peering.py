"""Peer cut-offs that follow the record log."""

from larder.operators import peer_views
from larder.operators.peers import category_panels
from larder.operators.tables import nutrition_table, product_table
from larder.sources.record_log import read_log


def record_panels(records):
    return category_panels(product_table(records), nutrition_table(records))


def follow_log(spark, log_root, view_root, batch, rule, **options):
    """Brings the view of cut-offs up to a batch that was appended to the record log."""
    before, after = peer_views.batch_changes(read_log(spark, log_root), batch)
    peer_views.update(spark, view_root, batch, record_panels(before), record_panels(after), rule, **options)
