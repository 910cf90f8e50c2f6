"""The conflict rules taken one after another over all known facts: what the indexed fold must equal."""

from palimpsest.operators.reconcile import _cosine, content_words, polarity, single_valued


class Fold:
    """Known facts of one (user, subject) key, taken in one at a time."""

    def __init__(self, similar: float | None = None, judge=None, band: float = 0.12):
        self.similar, self.judge, self.band = similar, judge, band
        self.facts: list[dict] = []

    @staticmethod
    def same(a: str, b: str) -> bool:
        return a.strip().lower() == b.strip().lower()

    def _live(self, new: dict) -> list[dict]:
        t = new["created_at"]
        return [
            f for f in self.facts
            if f["valid_at"] <= t and (f["expired_at"] is None or f["expired_at"] > t) and (f["invalid_at"] is None or f["invalid_at"] > t)
        ]

    def take(self, new: dict) -> bool:
        """Whether the fact is kept; what it replaces is retired either way."""
        live = self._live(new)
        slot = [f for f in live if f["subject"].lower() == new["subject"].lower() and f["predicate"].lower() == new["predicate"].lower()]
        if any(self.same(f["object"], new["object"]) for f in slot):
            return False
        single, by_user = single_valued(new["predicate"]), new["source"] == "user"
        if single and not by_user and any(f["source"] == "user" for f in slot):
            return False
        gone: list[dict] = []

        def retire(old: dict) -> None:
            old["invalid_at"] = new["valid_at"] if old["invalid_at"] is None else old["invalid_at"]
            old["expired_at"] = new["created_at"]
            gone.append(old)

        def yields(old: dict) -> bool:
            return (by_user or old["source"] != "user") and new["valid_at"] >= old["valid_at"] and not any(old is g for g in gone)

        side = polarity(new["predicate"])
        if side:
            for old in live:
                other = polarity(old["predicate"])
                if other and other != side and self.same(old["subject"], new["subject"]) and self.same(old["object"], new["object"]) and yields(old):
                    retire(old)
        said = content_words(new["object"])
        for old in slot if said else []:
            known = content_words(old["object"])
            if said < known:
                return False  # what was retired above stays retired
            if known and known < said and yields(old):
                retire(old)
        if single:
            for old in slot:
                if yields(old):
                    retire(old)
            if self.similar is not None and new.get("embedding") is not None and not by_user:
                self._replace_similar(new, live, slot, yields, retire)
        if gone:
            new["supersedes"] = max(gone, key=lambda f: f["valid_at"])["fact_id"]
        self.facts.append(new)
        return True

    def _replace_similar(self, new, live, slot, yields, retire) -> None:
        """Another slot of the subject whose fact means the same attribute; never one said in the same breath."""
        for old in live:
            if any(old is s for s in slot) or not yields(old) or old.get("embedding") is None or not single_valued(old["predicate"]):
                continue
            if not self.same(old["subject"], new["subject"]) or self.same(old["object"], new["object"]):
                continue
            if set(new["provenance"] or ()) & set(old["provenance"] or ()):
                continue
            near = _cosine(new["embedding"], old["embedding"])
            if near >= self.similar or (self.judge and near >= self.similar - self.band and self.judge(new, old)):
                retire(old)
