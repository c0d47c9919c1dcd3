"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks; a bidirectional LSTM reads the sequence of their tag-path and
hashed-word vectors in both directions and decides on every block with the whole page in view.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concord.llm.blocklabeller import Labeller, train
from concord.llm.common import map_batches
from concord.llm.htmlblocks import blocks_of, features, features_of
from concord.llm.pagemaker import Maker

#: Made-up pages that the labeller is trained on.
TRAIN_PAGES = 3000
#: Pages that are labelled at once.
GROUP = 256

_EXTRACTED = [T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_kept", T.IntegerType())]


@lru_cache(maxsize=2)
def default_labeller(pages: int = TRAIN_PAGES, seed: int = 5) -> Labeller:
    """The labeller, trained on made-up pages; the same for the same arguments."""
    maker, x, y = Maker(seed), [], []
    while len(x) < pages:
        html, labels = maker.page()
        blocks = blocks_of(html)
        if len(blocks) == len(labels):
            x.append(features(blocks))
            y.append(labels)
    return train(x, y)


def extract(pages: DataFrame, html: str = "html", keeps: list[str] | None = None, labeller: Labeller | None = None) -> DataFrame:
    """The columns `keeps` of pages, text, n_blocks and n_kept.

    text joins the blocks of main text in page order by one space; it is empty where there are
    none, as for null or empty html. Pages that repeat give the same text; an empty table gives
    no rows; columns of pages with the name of a new one are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller or default_labeller())

    def make():
        model = shared.value

        def run(cols):
            bodies, texts, sizes, kept = cols[html], [], [], []
            for at in range(0, len(bodies), GROUP):
                group = [blocks_of(x.as_py()) for x in bodies[at : at + GROUP]]
                for blocks, main in zip(group, model.label(features_of(group))):
                    texts.append(" ".join(b.text for b, m in zip(blocks, main) if m))
                    sizes.append(len(blocks))
                    kept.append(int(main.sum()))
            return {"text": pa.array(texts, pa.string()), "n_blocks": pa.array(sizes, pa.int32()), "n_kept": pa.array(kept, pa.int32())}

        return run

    return map_batches(pages, make, [html], keeps if keeps is not None else [c for c in pages.columns if c != html], _EXTRACTED)
