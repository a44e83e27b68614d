"""Settings: code defaults < file < key=value overrides. Unknown keys of a file are ignored."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # The defaults.
    chunk_size: int = 900
    chunk_overlap: int = 150
    min_chunk_chars: int = 120
    contextual_headers: bool = True
    embed_backend: str = "auto"
    mode: str = "weighted"
    top_k: int = 6
    candidate_k: int = 30
    rrf_k: int = 60
    dense_weight: float = 0.2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    expand_acronyms: bool = True
    max_chunks_per_doc: int = 2
    rerank: bool = False
    rerank_candidates: int = 30
    max_context_chars: int = 2200
    refusal_token: str = "INSUFFICIENT_CONTEXT"
    abstain: bool = True
    abstain_threshold: float | None = None
    abstain_max_false_refusal: float = 0.15
    seed: int = 42

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def merge(self, values: dict) -> Config:
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})

    def snapshot(self) -> dict:
        return asdict(self)

    def warnings(self) -> list[str]:
        out = []
        if self.chunk_overlap >= self.chunk_size:
            out.append("chunk_overlap is not less than chunk_size")
        if self.min_chunk_chars * 2 > self.chunk_size:
            out.append("min_chunk_chars is near chunk_size")
        return out


def parse_overrides(pairs: list[str]) -> dict:
    """``k=v`` strings with values typed as bool, null, int, float or text."""
    out: dict = {}
    for pair in pairs:
        key, _, raw = pair.partition("=")
        fixed = {"true": True, "false": False, "null": None, "none": None}
        if raw.lower() in fixed:
            out[key] = fixed[raw.lower()]
            continue
        for kind in (int, float, str):
            try:
                out[key] = kind(raw)
                break
            except ValueError:
                continue
    return out
