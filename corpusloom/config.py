"""Settings from the environment, and the embedders they name."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from corpusloom.operators.store import MOCK, Embedder, choose_embedder, model_embedder

#: The variables that are read, and the models taken where they are unset.
PROVIDER = "EMBEDDING_PROVIDER"
MODELS = {
    "local": ("LOCAL_EMBEDDING_MODEL", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"),
    "openai": ("OPENAI_EMBEDDING_MODEL", "text-embedding-3-small"),
    "gemini": ("GEMINI_EMBEDDING_MODEL", "gemini-embedding-001"),
}
GEMINI_KEYS = ("GEMINI_API_KEY", "GOOGLE_API_KEY")


@dataclass(frozen=True)
class Settings:
    """The provider of embeddings and each provider's model and key."""

    provider: str = "mock"
    models: dict[str, str] = field(default_factory=lambda: {k: default for k, (_, default) in MODELS.items()})
    gemini_key: str | None = None

    @staticmethod
    def read(environ: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if environ is None else environ
        key = next((env[k] for k in GEMINI_KEYS if env.get(k)), None)
        return Settings(env.get(PROVIDER, "mock").strip().lower(), {k: env.get(name) or default for k, (name, default) in MODELS.items()}, key)

    def embedder(self) -> Embedder:
        """The provider's embedder; the mock one if there is no such provider, or its library or key is missing."""
        return choose_embedder(self.provider, {"mock": lambda: MOCK, "local": self._local, "openai": self._openai, "gemini": self._gemini})

    # Libraries are imported here once, so that a missing one falls back at once, and again in every worker.
    def _local(self) -> Embedder:
        import sentence_transformers

        name = self.models["local"]

        def load():
            model = sentence_transformers.SentenceTransformer(name)
            return lambda texts: model.encode(texts, normalize_embeddings=True).tolist()

        return model_embedder(load, name)

    def _openai(self) -> Embedder:
        import openai

        name = self.models["openai"]

        def load():
            client = openai.OpenAI()
            return lambda texts: [list(x.embedding) for x in client.embeddings.create(model=name, input=texts).data]

        return model_embedder(load, name)

    def _gemini(self) -> Embedder:
        if not self.gemini_key:
            raise RuntimeError(f"one of {', '.join(GEMINI_KEYS)} must be set")
        from google import genai

        name, key = self.models["gemini"], self.gemini_key

        def load():
            client = genai.Client(api_key=key)
            return lambda texts: [list(x.values) for x in client.models.embed_content(model=name, contents=texts).embeddings]

        return model_embedder(load, name)
