import pytest


@pytest.fixture(scope="session")
def words():
    """Ordinary page text of a tiny invented vocabulary."""
    import random

    rng = random.Random(11)
    stock = "the harvest of oats round the mill is fair and carting will begin on monday so the board was told by the captain of a steamer from the north with many tons of coal and rope".split()
    return lambda n: " ".join(rng.choice(stock) for _ in range(n))
