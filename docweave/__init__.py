"""docweave: JSON-document dataflow operators on Spark.

Operators are functions from DataFrame to DataFrame built from Catalyst
expressions; they run the same way on batch and streaming DataFrames.
Documents are typed columns (``doc=None``) or one VARIANT column (``doc="doc"``).
"""

from pyspark import cloudpickle as _cloudpickle

import docweave as _self

# Functions of this package that run inside Python workers (user code,
# enrichment, pushes) are shipped by value, so executors need no install.
_cloudpickle.register_pickle_by_value(_self)

from docweave.functions.documents import as_documents, typed_from_documents  # noqa: E402
from docweave.functions.paths import get_field, has_field  # noqa: E402
from docweave.functions.predicates import Cond  # noqa: E402
from docweave.functions.sizing import broadcast_derived, sized_broadcast, spread  # noqa: E402
from docweave.operators.enrich import (enrich, enrich_from_table, short_code,  # noqa: E402
                                       short_code_collisions)
from docweave.operators.filter import filter_docs  # noqa: E402
from docweave.operators.reshape import (add_field, flatten_doc, prune_empty,  # noqa: E402
                                        remove_field, rename_field, set_doc, set_entity, trim)
from docweave.operators.routing import fan_out, merge, partition  # noqa: E402
from docweave.operators.split import (Split, branch, branch_exists, branch_fields,  # noqa: E402
                                      split, split_exists, split_fields)
from docweave.operators.user import flat_map_docs, map_batches, map_field, register_flat_map  # noqa: E402
from docweave.plans.components import component  # noqa: E402
from docweave.plans.dataflow import Edge, Dataflow  # noqa: E402
from docweave.session import checkpoint_root, configure, get_session  # noqa: E402
from docweave.sinks.payloads import (Widget, bars_payload, boxes_payload,  # noqa: E402
                                     map_payload, message_payload, timeline_payload)
from docweave.sinks.transactional import ledger, read_published, register_sink  # noqa: E402
from docweave.sinks.writers import (idempotency_key, log_sink, push_rows,  # noqa: E402
                                    push_sink, sink_from_function)
from docweave.functions.observed import FailureListener, observe_documents, observe_quarantined  # noqa: E402
from docweave.sources.custom import read_where, source_from_function  # noqa: E402
from docweave.sources.envelope import (classify_documents, decode_envelope,  # noqa: E402
                                       from_envelope, parse_documents, read_documents,
                                       read_kafka, split_malformed, to_envelope,
                                       with_documents)
from docweave.sources.feeds import (new_items, parse_feed, read_feed,  # noqa: E402
                                    snapshot_diff, with_poll_seq)
from docweave.sources.social import sample_stream, track_keyword_table, track_keywords  # noqa: E402

__version__ = "0.1.0"
