"""The queries of this subpackage; SQL where it can express them."""

from __future__ import annotations

from . import fertility, html_text, neighbours, packing, pieces, quality, simhash, substring, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        fertility.op1_fertility_rules,
        packing.op2_variable_best_fit,
        pieces.op3_unigram_pieces,
        simhash.op4_simhash_trie,
        html_text.op5_text_to_tag,
        toxicity.op6_toxic_lexicon,
        substring.op7_window_index,
        quality.op8_random_indexing,
        warc.op9_seekable_warc,
        neighbours.op10_nn_descent,
    )
}
ORACLE_SQL: dict[str, str] = {**substring.ORACLE_SQL, **warc.ORACLE_SQL}
