"""How toxicity.SHARE was chosen: `python tests/llm/share_by_folds.py SF_DIR ...` prints recall, precision and F1 at 0.7 of each
weight, over four folds inside the rows whose labels may be learnt; no held-out label is read."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).parents[2]))
from srcatlas.llm import toxicity as T  # noqa: E402
from srcatlas.llm.textvec import Words, slices  # noqa: E402

SHARES, FOLDS = (0.0, 0.1, 0.2, 0.35, 0.5, 0.7), 4


def fold_of(doc_id: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


def learnable_rows(folder: str):
    """Ids, texts and marks (1, 0, nan without any label) of the rows that may be fitted."""
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pandas().dropna(subset=["doc_id"])
    docs = docs.fillna({"text": ""}).sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    labels = pq.read_table(f"{folder}/labels.parquet").to_pandas()
    known = labels.dropna(subset=["doc_id", "toxic"])
    known = known[[zlib.crc32(str(int(i)).encode()) % 3 != 1 for i in known.doc_id]].groupby("doc_id").toxic.max()
    marks = docs.doc_id.map(known)
    fit = marks.notna() | ~docs.doc_id.isin(set(labels.doc_id.dropna()))
    return docs.doc_id[fit].astype(int).tolist(), docs.text[fit].tolist(), marks[fit].to_numpy()


def main(folder: str) -> None:
    ids, texts, y = learnable_rows(folder)
    found: list[np.ndarray] = []
    for batch in slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text"):
        doc, slot = T.distinct(*T.slots(Words(batch.column("text"))))
        found += np.split(slot, np.searchsorted(doc, np.arange(1, batch.num_rows)))
    row, col = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    fold, known = np.array([fold_of(i) for i in ids]), ~np.isnan(y)
    counted = lambda some: np.bincount(col[some[row]], minlength=1 << T.BITS)
    n_unl = int((~known).sum())
    for share in SHARES if n_unl else (0.0,):
        hits = lost = wrong = 0
        for k in range(FOLDS):
            hid, test = known & (fold != k), known & (fold == k)
            pos = hid & (y == 1)
            n_hid, n_pos = int(hid.sum()), int(pos.sum())
            prior = n_pos / n_hid
            usual = (1 - share) * counted(hid) / n_hid + (share * counted(~known) / n_unl if share else 0)
            lift = ((counted(pos) + 0.5) / (n_pos + 1)) / ((usual * n_hid + 0.5) / (n_hid + 1))
            sure = np.flatnonzero((counted(pos) >= T.LEAST_TEXTS) & (lift > T.LIFT / prior))
            rank = np.full(1 << T.BITS, -1)
            rank[sure] = np.arange(len(sure))
            hit = rank[col] >= 0
            kept = np.split(rank[col][hit], np.searchsorted(row[hit], np.arange(1, len(found))))
            fit = np.flatnonzero(hid | ~known)
            weight = np.where(hid[fit], (1 - share) / n_hid, share / max(1, n_unl))
            w, bias = T.fit_nnpu([kept[i] for i in fit], pos[fit].astype(int), len(sure), prior, weight)
            for i in np.flatnonzero(test):
                says, is_toxic = w[kept[i]].sum() + bias >= np.log(0.7 / 0.3), y[i] == 1
                hits, lost, wrong = hits + (says and is_toxic), lost + (is_toxic and not says), wrong + (says and not is_toxic)
        print(f"{folder} share {share}: found {hits}, lost {lost}, wrong {wrong}, F1 {2 * hits / max(1, 2 * hits + lost + wrong):.3f}", flush=True)


if __name__ == "__main__":
    for each in sys.argv[1:]:
        main(each)
