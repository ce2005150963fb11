"""Run settings shared by the plans. Every field can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass, field

# Class names, method names and defaults that results depend on.
CLASSES = ("benign", "malicious")
DEFAULT_CLASS = "malicious"
BALANCE_METHODS = ("none", "smote", "oversampling", "undersampling")
ALGORITHMS = ("decision_tree", "random_forest", "xgboost", "svm")
URL_ALIASES = ("url", "text", "input", "target")
LABEL_ALIASES = ("label", "class", "output", "type", "is_spam", "threat")
TEST_URL_ALIASES = ("url", "URL", "input", "target", "link")


@dataclass(frozen=True)
class Settings:
    """Training settings: seed, hold-out share, folds and search effort."""

    seed: int = 42
    test_size: float = 0.3
    folds: int = 5
    candidates: int = 20
    parallelism: int = 4
    algorithms: tuple[str, ...] = ALGORITHMS
    balance_method: str | None = None
    apply_balancing: bool = True
    # False balances before the split (synthetic rows may reach the test part);
    # True splits first and balances the training part only.
    balance_train_only: bool = False
    grids: dict = field(default_factory=dict)

    def __post_init__(self):
        check_algorithms(self.algorithms)
        check_balance_method(self.balance_method)


def check_algorithms(names) -> None:
    unknown = [n for n in names if n not in ALGORITHMS]
    if unknown:
        raise ValueError(
            f"there is no algorithm {', '.join(map(repr, unknown))}, only {', '.join(ALGORITHMS)}"
        )


def check_balance_method(name: str | None) -> None:
    if name is not None and name not in BALANCE_METHODS:
        raise ValueError(
            f"classes cannot be balanced by {name!r}, only by {', '.join(BALANCE_METHODS)}"
        )
