"""Analytics over collections of perturbation screens, as Spark DataFrame operators."""
