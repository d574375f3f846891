"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .common import prepare
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language_id import op2_language_id
from .mixing import op6_mixing
from .packing import op1_best_fit_packing
from .pii import op5_pii
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op10_quality_rules
from .secret_scan import op11_secret_scan
from .sharding import op3_sharding
from .simhash_dedup import op7_simhash_dedup
from .suffix_dedup import op8_suffix_dedup
from .wavelet import op9_wavelet_output


def _prepared(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {fn.__name__: _prepared(fn) for fn in (
    op1_best_fit_packing,
    op2_language_id,
    op3_sharding,
    op4_exact_dedup,
    op5_pii,
    op6_mixing,
    op7_simhash_dedup,
    op8_suffix_dedup,
    op9_wavelet_output,
    op10_quality_rules,
    op11_secret_scan,
    op12_prefix_trie,
    op13_hard_negatives,
)}

ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
