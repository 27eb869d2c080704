"""Plans that put operators together: layer fold, SVG and G-code output."""
