"""The queries of this subpackage and the SQL that they are checked against, where SQL can express them."""

from __future__ import annotations

from harrier.llm import collocations, prefix_trie, url_filters
from harrier.llm.byte_bpe import op12_byte_bpe
from harrier.llm.collocations import op11_collocations
from harrier.llm.decontamination import op5_decontamination
from harrier.llm.jaccard_join import op2_ngram_jaccard_join
from harrier.llm.language_id import op10_language_id
from harrier.llm.mixing import op3_source_mixing
from harrier.llm.prefix_trie import op13_prefix_trie
from harrier.llm.quality import op8_quality_classifier
from harrier.llm.substring_dedup import op4_substring_dedup
from harrier.llm.token_files import op7_token_files
from harrier.llm.toxicity import op6_toxicity
from harrier.llm.url_filters import op1_url_filters
from harrier.llm.winnowing import op9_winnowing

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_ngram_jaccard_join,
        op3_source_mixing,
        op4_substring_dedup,
        op5_decontamination,
        op6_toxicity,
        op7_token_files,
        op8_quality_classifier,
        op9_winnowing,
        op10_language_id,
        op11_collocations,
        op12_byte_bpe,
        op13_prefix_trie,
    )
}

#: op2 and op4 written as relations over all shingles and windows; words as the contracts have them.
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filters.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.m, d.doc_id)) AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) r USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM edges WHERE same GROUP BY x) c USING (doc_id)
""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, p + k AS q FROM (SELECT win.doc_id, win.p, unnest(range(0, 13)) AS k FROM win JOIN least USING (g) WHERE least.m < win.doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d WHERE len(w) > 0),
kept AS (
  SELECT words.doc_id, count(hit.q) AS n_removed, sha256(coalesce(string_agg(CASE WHEN hit.q IS NULL THEN x END, ' ' ORDER BY words.q), '')) AS kept_sha256
  FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.q = hit.q GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
}
