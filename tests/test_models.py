"""The adapters of optional libraries, over stand-ins of those libraries."""

import sys
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest

from verbascope.operators import models


@pytest.fixture
def library(monkeypatch):
    def add(name, **members):
        module = ModuleType(name)
        for k, v in members.items():
            setattr(module, k, v)
        monkeypatch.setitem(sys.modules, name, module)
        return module

    return add


def test_sentence_model(library):
    class SentenceTransformer:
        def __init__(self, name):
            self.name = name

        def encode(self, texts, convert_to_numpy, show_progress_bar):
            assert convert_to_numpy and not show_progress_bar
            return np.array([[len(t), 1.0] for t in texts], np.float32)

    library("sentence_transformers", SentenceTransformer=SentenceTransformer)
    model = models.SentenceModel("some-model")
    assert model.encode(["ab", ""]).tolist() == [[2, 1], [0, 1]] and "some-model" in model.name


class Array(np.ndarray):
    """A tensor: an array with the methods that the adapter calls."""

    def bool(self):
        return self.astype(bool)

    def numpy(self):
        return np.asarray(self)


def tensor(values):
    return np.array(values).view(Array)


def test_context_model(library):
    """Texts of unlike length are padded; padding is dropped, specials stand at (0, 0), and long texts are cut."""

    def tokenizer(texts, return_tensors, padding, truncation, max_length, return_offsets_mapping):
        assert (return_tensors, padding, truncation, return_offsets_mapping) == ("pt", True, True, True)
        rows = []
        for t in texts:
            at, places = 0, [(0, 0)]
            for word in t.split()[: max_length - 2]:
                at = t.index(word, at)
                places.append((at, at + len(word)))
                at += len(word)
            rows.append([*places, (0, 0)])
        longest = max(map(len, rows))
        mask = [[1] * len(r) + [0] * (longest - len(r)) for r in rows]
        return {"offset_mapping": tensor([r + [(0, 0)] * (longest - len(r)) for r in rows]), "attention_mask": tensor(mask)}

    class Model:
        def eval(self):
            return self

        def __call__(self, attention_mask):
            n, m = attention_mask.shape
            return SimpleNamespace(last_hidden_state=tensor(np.arange(n * m * 2, dtype=np.float32).reshape(n, m, 2)))

    class NoGrad:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    library("torch", no_grad=NoGrad)
    library("transformers", AutoTokenizer=SimpleNamespace(from_pretrained=lambda name, use_fast: tokenizer), AutoModel=SimpleNamespace(from_pretrained=lambda name: Model()))
    model = models.ContextModel("some-model", longest=4)
    one, two = model.tokens(["make it up", "x"])
    assert [(s, e) for s, e, _ in one] == [(0, 0), (0, 4), (5, 7), (0, 0)] and [(s, e) for s, e, _ in two] == [(0, 0), (0, 1), (0, 0)]
    assert [v.tolist() for _, _, v in two] == [[8, 9], [10, 11], [12, 13]]


def test_tagged_words(library):
    library("nltk", pos_tag=lambda words: [(w, {"ran": "VBD", "quickly": "RB", "dogs": "NNS"}.get(w, "DT")) for w in words])
    library("nltk.stem", WordNetLemmatizer=lambda: SimpleNamespace(lemmatize=lambda w, kind: {("ran", "v"): "run", ("dogs", "n"): "dog"}.get((w, kind), w)))
    library("nltk.tokenize", TreebankWordTokenizer=lambda: SimpleNamespace(tokenize=str.split))
    found = models.TaggedWords().analyze(["the dogs ran quickly", ""])
    assert [(w, t, lemma) for w, t, lemma, _, _ in found[0]] == [("the", "DT", "the"), ("dogs", "NNS", "dog"), ("ran", "VBD", "run"), ("quickly", "RB", "quickly")] and found[1] == []


def test_lemma_model(library):
    token = lambda text, tag, lemma, idx: SimpleNamespace(text=text, tag_=tag, lemma_=lemma, idx=idx)
    library("spacy", load=lambda name: SimpleNamespace(pipe=lambda texts: [[token("made", "VBD", "make", 4), token("up", "RP", "up", 9)] for _ in texts]))
    assert models.LemmaModel("m").analyze(["She made up"]) == [[("made", "VBD", "make", 4, 8), ("up", "RP", "up", 9, 11)]]
