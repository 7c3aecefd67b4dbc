"""The rejection threshold comes from the whole sample, measured on texts that the model hasn't seen."""

import random

from gustfield.llm import language


def test_limit_is_of_all_texts_held_out():
    r = random.Random(4)
    plain = [f"aa {' '.join(r.choice(['and', 'all', 'any']) for _ in range(30))} {i}" for i in range(420)]
    varied = lambda: "z " + " ".join("".join(r.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12))
    samples = {"x": sorted(language.normal(t) for t in plain + [varied() for _ in range(60)])}
    model = language.Model(samples)
    model.calibrate(samples)
    assert not any(rejected for *_, rejected in model.predict([varied() for _ in range(40)]))
