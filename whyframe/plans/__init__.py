"""Query plans: Catalyst access and plan descriptors."""
