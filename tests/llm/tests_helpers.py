from __future__ import annotations

from test_pairs_and_groups import brute_components


def brute_kept(df) -> set[int]:
    """Ids that stay when one document, the least id, stays of each component (five words, similarity 0.8)."""
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    comp, _ = brute_components([t for _, t in rows], 5, 80, 100)
    return {rows[k][0] for k in range(len(rows)) if comp[k] == k}
