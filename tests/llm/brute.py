"""Plain versions of the operators, for small tables."""

import hashlib


def remove_repeats(rows, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    first = {}
    for doc_id, text in rows:
        body = (text or "").encode()
        for at in range(len(body) - window + 1):
            if doc_id is not None:
                first[body[at:at + window]] = min(doc_id, first.get(body[at:at + window], doc_id))
    out = []
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for at in range(len(body) - window + 1):
            if doc_id is not None and first[body[at:at + window]] < doc_id:
                gone[at:at + window] = b"\1" * window
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
