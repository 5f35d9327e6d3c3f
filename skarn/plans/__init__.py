"""Looking at plans: operators, pushed filters, columns read, estimates, rule switches."""
