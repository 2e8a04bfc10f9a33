"""Adapters of optional libraries to the plug-in points; each is imported in the worker that uses it."""

from __future__ import annotations

import numpy as np


class SentenceModel:
    """A sentence encoder of the sentence-transformers library."""

    def __init__(self, model: str = "all-MiniLM-L6-v2"):
        from sentence_transformers import SentenceTransformer

        self.name, self.model = f"sentence model ({model})", SentenceTransformer(model)

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.model.encode(texts, convert_to_numpy=True, show_progress_bar=False)


class ContextModel:
    """Token vectors of a transformers model, of texts cut at ``longest`` tokens."""

    def __init__(self, model: str = "bert-base-uncased", longest: int = 512):
        import torch
        from transformers import AutoModel, AutoTokenizer

        self.name, self.longest, self.torch = f"context model ({model})", longest, torch
        self.tokenizer, self.model = AutoTokenizer.from_pretrained(model, use_fast=True), AutoModel.from_pretrained(model).eval()

    def tokens(self, texts: list[str]) -> list[list[tuple[int, int, np.ndarray]]]:
        made = self.tokenizer(texts, return_tensors="pt", padding=True, truncation=True, max_length=self.longest, return_offsets_mapping=True)
        places, mask = made.pop("offset_mapping").tolist(), made["attention_mask"].bool()
        with self.torch.no_grad():
            vectors = self.model(**made).last_hidden_state
        return [[(s, e, v) for (s, e), v, keep in zip(p, x.numpy(), m.tolist(), strict=True) if keep] for p, x, m in zip(places, vectors, mask, strict=True)]


class TaggedWords:
    """Words, tags and lemmas of the nltk library."""

    def __init__(self):
        from nltk import pos_tag
        from nltk.stem import WordNetLemmatizer
        from nltk.tokenize import TreebankWordTokenizer

        from verbascope.functions.text import POS

        self.tag, self.lemmatizer, self.tokenizer, self.kinds = pos_tag, WordNetLemmatizer(), TreebankWordTokenizer(), POS

    def analyze(self, texts: list[str]) -> list[list[tuple[str, str, str, int, int]]]:
        out = []
        for text in texts:
            words = self.tokenizer.tokenize(text)
            tagged = self.tag(words)
            out.append([(w, t, self.lemmatizer.lemmatize(w, self.kinds[t[:1]]) if t[:1] in self.kinds else w, -1, -1) for w, t in tagged])
        return out


class LemmaModel:
    """Words and lemmas, with their places, of a spaCy pipeline."""

    def __init__(self, model: str = "en_core_web_trf"):
        import spacy

        self.model = spacy.load(model)

    def analyze(self, texts: list[str]) -> list[list[tuple[str, str, str, int, int]]]:
        return [[(t.text, t.tag_, t.lemma_, t.idx, t.idx + len(t.text)) for t in doc] for doc in self.model.pipe(texts)]

