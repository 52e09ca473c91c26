"""What a Python worker keeps from one step to the next."""

import public_tokenizers
import pytest

from strandlake.llm import minhash, tokens
from strandlake.llm._common import let_go


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_other_steps_free_the_kept_encoder(name, drops):
    path = public_tokenizers.path(name)
    kept = tokens.Encoder.kept(path, drops)
    want = kept.ids(["Some words, some CUEs: 12 naïve ones\n\n again"])
    assert tokens.Encoder.kept(path, drops) is kept and len(kept.pieces_known)
    list(minhash._signatures(5, 50)([]))  # a task of another step in this worker
    assert not kept.pieces_known and not kept.parts_known and tokens.Encoder.kept(path, drops) is not kept
    assert tokens.Encoder.kept(path, drops).ids(["Some words, some CUEs: 12 naïve ones\n\n again"]) == want
    let_go()
