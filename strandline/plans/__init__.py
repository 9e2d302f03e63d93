"""Plans that run several operators and publish their result."""
