"""Building blocks of plans: tables in the shared folder, components, prefix sums."""
