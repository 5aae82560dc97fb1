import os

import numpy as np
import pytest

from curatrix.llm import sentencepiece_codec as C
from curatrix.llm.queries import SENTENCEPIECE_MODEL


@pytest.mark.skipif(not os.path.exists(SENTENCEPIECE_MODEL), reason="the public model file is not here")
def test_parity_covers_every_whole_text():
    codec = C.Codec(SENTENCEPIECE_MODEL)
    texts = ["one two", "three  four", "five six", " "]
    assert all(codec.encode(texts)[1])
    codec._made[C.MARK + "six"] = np.array([5, 6], "<i4").tobytes()  # a wrong part in the third text
    codec._made[C.MARK * 2] = np.array([7], "<i4").tobytes()  # and wrong markers alone
    assert codec.encode(texts)[1] == [True, True, False, False]
