import gc
import weakref

import pandas as pd
import public_tokenizers
import pytest

from tallyfold.llm import bpe, jaccard, toxicity

FILE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


class Ran(Exception):
    """The task is done; the plan behind it is not run here."""


class Here:
    """Stands for a table: runs a task's function in this process, as a Python worker does that is used again."""

    def __init__(self, batch):
        self.batch = batch

    def mapInPandas(self, run, schema):  # noqa: N802
        list(run(iter([self.batch])))
        raise Ran


SETS = pd.DataFrame({"text": [b"a b c d e f"], "node": [1], "doc_id": [1], "key": [1]})
TERMS = pd.DataFrame({"text": ["a b c"], "toxic": [1]})


@pytest.mark.parametrize("task", [lambda: jaccard._sets(Here(SETS), 5), lambda: toxicity._terms(Here(TERMS), 1)], ids=["near copies", "toxicity"])
def test_tables_of_another_operator_do_not_stay_in_a_worker(task):
    own = bpe.codec(FILE)
    assert bpe.codec(FILE) is own
    left = weakref.ref(own)
    del own
    gc.collect()
    assert left() is not None
    with pytest.raises(Ran):
        task()
    gc.collect()
    assert left() is None
